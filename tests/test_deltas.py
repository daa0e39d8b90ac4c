import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from yieldloom.operators import deltas, facts, qr
from yieldloom.plans import bindings
from yieldloom.sources import sinks

SF = "/root/testdata/sf0.001"
ENTRY = "file_name string, report_date date, qr_hash string"


def _entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_bitmaps_equal_recounts(spark):
    rng, day = random.Random(3), dt.date(2026, 1, 1)
    rows = [(f"F{rng.randrange(4)}", day + dt.timedelta(days=rng.randrange(3)), f"c{rng.randrange(60)}") for _ in range(500)]
    none = spark.createDataFrame([], "qr_hash string, number long")
    old = _entries(spark, rows)
    codes = sinks.staged(qr.number_codes(none, old, buckets=7))
    numbers = sorted(r.number for r in codes.collect())
    assert numbers == list(range(1, len({r[2] for r in rows}) + 1))
    bits = sinks.staged(qr.code_bitmaps(old, codes))
    summary = qr.bitmap_daily(bits)
    new = [("F1", day + dt.timedelta(days=5), "c1"), ("F1", day, "fresh"), ("F1", day, "fresh"), ("F1", day, None)]
    more = sinks.staged(qr.number_codes(codes, _entries(spark, new), buckets=7))
    assert more.join(codes, ["qr_hash", "number"], "left_semi").count() == codes.count() and more.agg(F.max("number")).first()[0] == len(numbers) + 1
    now, counts = qr.replace_bitmaps(bits, summary, ["F1"], qr.code_bitmaps(_entries(spark, new), more))
    left = [r for r in rows if r[0] != "F1"] + new[:3]
    want = {d: len({c for _, e, c in left if e == d}) for d in {r[1] for r in left}}
    assert {r.report_date: r.daily_count for r in counts.collect()} == want
    assert {r.report_date: r.daily_count for r in qr.bitmap_daily(now).collect()} == want
    gone = qr.replace_bitmaps(now, counts, ["F0", "F1", "F2", "F3"])[1]
    assert gone.count() == 0


def test_wide_numbers_go_to_further_buckets(spark):
    codes = spark.range(1, 70_001).select(F.concat(F.lit("c"), "id").alias("qr_hash"), F.col("id").alias("number"))
    entries = codes.select(F.lit("F").alias("file_name"), F.lit("2026-01-01").cast("date").alias("report_date"), "qr_hash")
    bits = qr.code_bitmaps(entries, codes)
    assert bits.count() == 3 and qr.bitmap_daily(bits).first().daily_count == 70_000


def test_repeated_batches_change_nothing(spark, tmp_path):
    log = bindings.plog(spark, SF)
    none = facts.weighted(log.limit(0))
    sums = deltas.DaySums(spark, str(tmp_path / "s"))
    assert sums.rows().count() == 0
    every = facts.weighted(log)

    def want(rows):
        return sorted(map(tuple, deltas.day_deltas(rows, none).collect()))

    for batch in (0, 0):
        sums.apply(batch, every, none)
        assert sorted(map(tuple, sums.rows().collect())) == want(every)
    half = facts.weighted(log.where("id % 2 = 0"))
    sums.apply(1, none, half)
    sums.fold(0)
    again = deltas.DaySums(spark, str(tmp_path / "s"))
    for batch in (0, 1):
        again.apply(batch, *((every, none) if batch == 0 else (none, half)))
        assert sorted(map(tuple, again.rows().collect())) == want(facts.weighted(log.where("id % 2 <> 0")))
    again.apply(2, none, facts.weighted(log.where("id % 2 <> 0")))
    again.fold(2)
    assert again.rows().count() == 0


def test_unknown_changes_fail(spark):
    feed = bindings.plog(spark, SF).limit(3).withColumn("op", F.lit("drop"))
    with pytest.raises(Exception, match="unknown change drop"):
        deltas.changes(feed)[0].collect()
