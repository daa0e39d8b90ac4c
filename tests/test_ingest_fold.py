"""Folding an ingest's batches into a base: nothing changes but what is read."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from test_ingest import HEAD, _line

from yieldloom.operators import archive, election
from yieldloom.sources import sinks
from yieldloom.streaming import ingest


def _rows(spark, folder, files):
    out = None
    for name, lines in files.items():
        path = folder / name
        path.write_text("\n".join([HEAD, *lines]) + "\n", encoding="utf-8")
        part = spark.read.schema(ingest.LOG_SCHEMA).option("header", True).csv(str(path)).selectExpr("*", f"'{name}' AS source_file")
        out = part if out is None else out.unionByName(part)
    return out


def _batches(seed, batches=3):
    rng = random.Random(seed)
    for _ in range(batches):
        names = rng.sample(["a.csv", "b.csv", "c.csv", "d.csv"], 2)
        yield {n: [_line(rng.choice(["", "K1", "K2", "K3", "K4"]), f"2026-01-05 10:{rng.randrange(4):02d}:00") for _ in range(rng.randrange(1, 5))] for n in names}


def _state(store, before=None):
    return sorted((r.file_name, r.dedup_key or "", r.dedup_time, r.id) for r in store.winners(before).collect())


def _elected(store):
    return {r.id for r in election.elect_winners(store.table("candidates"), store.heads()).collect()}


def test_folds_change_nothing_but_what_is_read(spark, tmp_path):
    folded = ingest.UnitStore(spark, str(tmp_path / "folded"), buckets=4)
    for number, files in enumerate(_batches(3)):
        rows = _rows(spark, tmp_path, files)
        ingest.publish_batch(folded, rows, number)
        assert {w[3] for w in _state(folded)} == _elected(folded)
        if number < 2:
            before = _state(folded)
            folded.fold(number)
            assert folded.upto() == number and _state(folded) == before
            folded.fold(number)
    now = _state(folded)

    # a batch that comes again: one that the base holds changes nothing, one after it replaces itself
    ingest.publish_batch(folded, rows.limit(0), 1)
    ingest.publish_batch(folded, rows, 2)
    assert _state(folded) == now
    with pytest.raises(ValueError, match="folded"):
        folded.winners(1)

    # the base is found again by a session that doesn't know its table, and older ones go
    spark.sql(f"DROP TABLE units_{folded._newest()[2]}")
    again = ingest.UnitStore(spark, str(tmp_path / "folded"), buckets=2)
    assert _state(again) == now
    again.fold(2)
    assert _state(again) == now and len(list((tmp_path / "folded" / "units").iterdir())) == 2


def test_compacted_units_leave_the_store_and_stay_counted(spark, tmp_path):
    store = ingest.UnitStore(spark, str(tmp_path / "store"), buckets=4)
    old, new = "2026-01-04 10:00:00", "2026-01-06 10:00:00"
    ingest.publish_batch(store, _rows(spark, tmp_path, {"a.csv": [_line("K1", old), _line("", old), _line("K2", new)], "b.csv": [_line("K1", new), _line("K3", old), _line("K4", new)]}), 0)
    keys = archive.Archive.create(spark.createDataFrame([], "line string, dedup_key string, dedup_time long, file_name string"), buckets=4)
    store.compact(0, dt.date(2026, 1, 5), keys)

    def units():
        return sorted((w[0], w[1]) for w in _state(store))

    def grouped():
        return store.groups().agg(F.sum("quantity")).first()[0]

    assert units() == [("a.csv", "K2"), ("b.csv", "K4")] and grouped() == 3
    assert sorted(r.dedup_key for r in keys.rows().collect()) == ["K1", "K3"]
    policy = {"cutoff": "2026-01-05", "archived": keys}
    # K1 doesn't win again; a file with archived rows can't be replaced
    ingest.publish_batch(store, _rows(spark, tmp_path, {"c.csv": [_line("K1", new), _line("K5", new)], "a.csv": [_line("K6", new)]}), 1, **policy)
    assert units() == [("a.csv", "K2"), ("b.csv", "K4"), ("c.csv", "K5")]
    assert [(r.file_name, r.reason) for r in store.table("refused").collect()] == [("a.csv", "guarded")]
    assert [r.archived_duplicates for r in store.table("counts").where("batch = 1").collect()] == [1]
    # a later cutoff adds to the groups; the same one again, without new batches, changes nothing
    for _ in range(2):
        store.compact(1, dt.date(2026, 1, 7), keys)
        assert units() == [] and grouped() == 6 and keys.rows().count() == 5


def test_a_batch_reads_its_buckets_and_does_not_shuffle_the_base(spark, tmp_path):
    store = ingest.UnitStore(spark, str(tmp_path / "store"), buckets=8)
    ingest.publish_batch(store, _rows(spark, tmp_path, {"a.csv": [_line(f"K{k}", "2026-01-05 10:00:00") for k in range(40)], "b.csv": [_line("", "2026-01-05 10:00:00")]}), 0)
    store.fold(0)
    units = ingest.parse_batch(_rows(spark, tmp_path, {"n.csv": [_line("K7", "2026-01-05 09:00:00"), _line("", "2026-01-05 09:00:00")]}), 1, "DAF")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = store.touched(units, 1)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r.dedup_key, r.wins) for r in got.collect()] == [("K7", True)]
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "units" in line)
    assert "Bucketed: true" in scan and "bucket#" in scan.split("PartitionFilters: ")[1].split("]")[0]
    # above the scan there is a join of sorted buckets before there is any exchange
    above = plan[: plan.index(scan)].splitlines()
    assert "Exchange" not in "".join(above[max(k for k, line in enumerate(above) if "SortMergeJoin" in line and "LeftSemi" in line and "unit" in line):])


def test_empty_batches_and_repeated_files(spark, tmp_path, monkeypatch):
    paths, made = [], sinks.scratch_path
    monkeypatch.setattr(sinks, "scratch_path", lambda spark: paths.append(made(spark)) or paths[-1])
    store = ingest.UnitStore(spark, str(tmp_path / "store"), buckets=2)
    rows = _rows(spark, tmp_path, {"a.csv": [_line("K1", "2026-01-05 10:00:00"), _line("", "2026-01-05 10:00:00")]})
    ingest.publish_batch(store, rows.limit(0), 0)
    store.fold(0)
    assert _state(store) == []
    for number in (1, 2):
        ingest.publish_batch(store, rows, number)
        store.fold(number)
        assert [(w[0], w[1], w[3] // ingest.BATCH_IDS) for w in _state(store)] == [("a.csv", "", number), ("a.csv", "K1", number)]
    assert paths and not any(os.path.exists(p) for p in paths)
