"""Distinct codes scanned in a day, over files that may be replaced or deleted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text

MOST_ENTRIES = 25_000


def qr_entries(scans: DataFrame) -> DataFrame:
    """file_name, report_date, qr_hash of scans (file_name, qr, time); blank codes are left out, a code
    with an invalid time fails the job."""
    rows = scans.where(F.coalesce(F.trim("qr"), F.lit("")) != "")
    day = dates.parse_stamp(F.col("time"))
    ok = records.require(day.isNotNull(), F.concat(F.lit("invalid time in "), F.col("file_name")))
    return rows.where(ok).select("file_name", day.alias("report_date"), text.sha_hex(F.trim("qr")).alias("qr_hash"))


def qr_set(entries: DataFrame) -> DataFrame:
    """Each code once for each file and day."""
    return entries.dropDuplicates(["file_name", "report_date", "qr_hash"])


def validate_qr_entries(entries: DataFrame) -> DataFrame:
    """file_name, entries, bad, ok: hashes of 64 hex digits, existing dates, 1 to 25,000 entries."""
    day = F.col("report_date").cast("string")
    rules = {"hash": F.col("qr_hash").rlike("^[0-9a-f]{64}$"), "date": dates.is_valid_iso_date(day)}
    out = entries.groupBy("file_name").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.size(records.failures(rules)) > 0).alias("bad"))
    return out.withColumn("ok", (F.col("bad") == 0) & F.col("entries").between(1, MOST_ENTRIES))


def qr_daily(entries: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """report_date and its number of distinct codes; of some days only if ``days`` are given."""
    if days is not None:
        entries = entries.join(days.select("report_date").distinct(), "report_date", "left_semi")
    return entries.groupBy("report_date").agg(F.count_distinct("qr_hash").alias("daily_count"))


def refresh_days(summary: DataFrame, entries: DataFrame, days: DataFrame) -> DataFrame:
    """Day counts with those of ``days`` counted anew; days without codes drop out."""
    rest = summary.join(days.select("report_date").distinct(), "report_date", "left_anti")
    return rest.unionByName(qr_daily(entries, days))


def replace_qr_file(entries: DataFrame, summary: DataFrame, file: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and day counts after a file's entries were replaced by ``rows``."""
    old = entries.where(F.col("file_name") == file)
    now = entries.where(F.col("file_name") != file).unionByName(qr_set(rows).select(*entries.columns))
    days = old.select("report_date").union(rows.select("report_date")).distinct()
    return now, refresh_days(summary, now, days)


def delete_qr_file(entries: DataFrame, summary: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Entries and day counts without a file."""
    return replace_qr_file(entries, summary, file, entries.where(F.lit(False)))


def number_codes(codes: DataFrame, entries: DataFrame, buckets: int = 4096) -> DataFrame:
    """``codes`` (qr_hash, number) with the codes of ``entries`` that have no number yet, numbered on from the last
    one (from 1). Numbers never change, so bitmaps over them stay right."""
    fresh = entries.select("qr_hash").where("qr_hash is not null").distinct().join(codes, "qr_hash", "left_anti")
    numbered = rates.with_bucketed_rank(fresh, [], F.pmod(F.xxhash64("qr_hash"), F.lit(buckets)), [F.col("qr_hash")], "number")
    last = codes.agg(F.coalesce(F.max("number"), F.lit(0)).alias("_last"))
    return codes.unionByName(records.with_bounds(numbered, last).select("qr_hash", (F.col("number") + F.col("_last")).alias("number")))


def code_bitmaps(entries: DataFrame, codes: DataFrame) -> DataFrame:
    """file_name, report_date, bucket, bits: the codes of a file and day as bitmaps of 32,768 numbers each."""
    placed = entries.join(codes, "qr_hash").withColumn("bucket", F.bitmap_bucket_number("number"))
    return placed.groupBy("file_name", "report_date", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def bitmap_counts(bitmaps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and their exact number of distinct codes: bitmaps of a key are merged, never their codes read."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("_n"))
    return merged.groupBy(*keys).agg(F.sum("_n").alias(name))


def bitmap_daily(bitmaps: DataFrame) -> DataFrame:
    """As :func:`qr_daily`, from bitmaps."""
    return bitmap_counts(bitmaps, ["report_date"], "daily_count")


def replace_bitmaps(bitmaps: DataFrame, summary: DataFrame, files: list[str], rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bitmaps and day counts after files were replaced by the bitmaps ``rows``, or deleted without them. Only bitmaps of
    the days that old or new rows of the files hold are merged again; days without codes drop out."""
    own = F.col("file_name").isin(*files)
    rows = bitmaps.where(F.lit(False)) if rows is None else rows.select(*bitmaps.columns)
    days = bitmaps.where(own).select("report_date").union(rows.select("report_date")).distinct()
    now = bitmaps.where(~F.coalesce(own, F.lit(False))).unionByName(rows)
    counted = bitmap_daily(now.join(days, "report_date", "left_semi"))
    return now, summary.join(days, "report_date", "left_anti").unionByName(counted)


def qr_kpis(summary: DataFrame, date: dt.date) -> DataFrame:
    """The day, its last seven days, its month so far: today, seven, month."""
    day, at = F.col("report_date").cast("date"), F.lit(date)

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("daily_count"))), F.lit(0))

    return summary.agg(
        total(day == at).alias("today"),
        total(day.between(F.date_sub(at, 6), at)).alias("seven"),
        total(day.between(F.trunc(at, "month"), at)).alias("month"),
    )


def qr_trend(summary: DataFrame, n: int = 14) -> DataFrame:
    """The last ``n`` producing days, ascending."""
    return summary.where("daily_count > 0").orderBy(F.desc("report_date")).limit(n).orderBy("report_date")


def qr_files(entries: DataFrame) -> DataFrame:
    """file_name, its number of codes and its days."""
    days = F.array_join(F.sort_array(F.collect_set(F.col("report_date").cast("string"))), ",")
    return entries.groupBy("file_name").agg(F.count(F.lit(1)).alias("codes"), days.alias("days"))
