"""Publication and deletion over archived units, on small stores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_operators import UNIT, ids, unit

from yieldloom.operators import archive, election, facts, retention

KEYS = "line string, dedup_key string, dedup_time long, file_name string"
HEAD = "line string, file_name string, job_id string"


@pytest.fixture
def store(spark):
    """File F1 has an archived unit A, file F2 the archived unit B without a time; C and D still count."""
    log = spark.createDataFrame([unit(1, "F1", "A", 10), unit(2, "F2", "B", None), unit(3, "F2", "C", 30), unit(4, "F3", "C", 40), unit(5, "F3", "D", 5)], UNIT)
    keys = spark.createDataFrame([("DAF", "A", 10, "F1"), ("DAF", "B", None, "F2")], KEYS)
    heads = log.select("line", "file_name", "job_id").distinct()
    groups = facts.compact_groups(log.where("id < 3"))
    return log.where("id in (3, 5)"), log, heads, archive.Archive.create(keys, buckets=8), groups


def upload(spark, *rows, file="F9"):
    return spark.createDataFrame(list(rows), UNIT), spark.createDataFrame([("DAF", file, "J" + file)], HEAD)


def test_archived_units_never_win_again(spark, store):
    winners, log, heads, keys, groups = store
    incoming, head = upload(spark, unit(10, "F9", "A", 11), unit(11, "F9", "B", None), unit(12, "F9", "C", 1), unit(13, "F9", "E", 1), unit(14, "F9", None, 1))
    done = archive.publish(winners, log, heads, incoming, head, keys, groups)
    assert ids(done.winners) == [5, 12, 13, 14]
    assert [tuple(r) for r in done.counts.collect()] == [("DAF", 3, 1, 2)]
    assert sorted(r.file_name for r in done.pairs.collect()) == ["F2", "F9"]
    back = archive.delete_file(done.winners, log.unionByName(incoming), done.heads, "DAF", "F9", keys, groups)
    assert ids(back.winners) == [3, 5]
    assert sorted(r.file_name for r in back.pairs.collect()) == ["F2", "F9"]
    again = archive.delete_file(back.winners, log.unionByName(incoming), back.heads, "DAF", "F9", keys, groups)
    assert ids(again.winners) == [3, 5] and again.pairs.count() == 0


@pytest.mark.parametrize(("key", "time", "refused"), [("A", 9, True), ("A", 10, False), ("A", None, False), ("B", 99, True), ("B", None, False), ("Z", 0, False)])
def test_missing_times_come_last_on_both_sides(spark, store, key, time, refused):
    winners, log, heads, keys, groups = store
    incoming, head = upload(spark, unit(10, "F9", key, time))
    assert election.earlier_than_archive(incoming, keys.rows()).count() == refused
    if refused:
        with pytest.raises(ValueError, match="earlier"):
            archive.publish(winners, log, heads, incoming, head, keys, groups)
    else:
        archive.publish(winners, log, heads, incoming, head, keys, groups)


def test_files_with_archived_rows_are_guarded(spark, store):
    winners, log, heads, keys, groups = store
    incoming, head = upload(spark, unit(10, "F1", "Q", 99), file="F1")
    with pytest.raises(ValueError, match="replaced"):
        archive.publish(winners, log, heads, incoming, head, keys, groups)
    with pytest.raises(ValueError, match="deleted"):
        archive.delete_file(winners, log, heads, "DAF", "F1", keys, groups)
    with pytest.raises(ValueError, match="before"):
        archive.publish(winners, log, heads, *upload(spark, unit(10, "F9", "Q", 99, date="2026-01-01")), keys, groups, "2026-02-01")


def test_the_archive_is_not_shuffled_and_only_touched_buckets_are_read(spark, store):
    keys = store[3]
    rows = spark.createDataFrame([("DAF", "A", 1), ("DAF", None, 2), ("FT1", "A", 3), ("DAF", "", 4)], "line string, dedup_key string, id int")
    asked = keys.beside(rows)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    assert "PartitionFilters: [bucket" in plan
    assert {(r.id, r.archived) for r in asked.collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert ids(keys.without(rows)) == [2, 3, 4]


def test_append_keeps_what_is_there(spark, store):
    keys = store[3]
    keys.append(spark.createDataFrame([("DAF", "A", 99, "F8"), ("DAF", "N", 7, "F8"), ("DAF", None, 1, "F8")], KEYS))
    assert sorted(map(tuple, keys.rows().collect()), key=str) == [("DAF", "A", 10, "F1"), ("DAF", "B", None, "F2"), ("DAF", "N", 7, "F8")]
    rows = spark.createDataFrame([("DAF", "N", 1)], "line string, dedup_key string, id int")
    assert keys.without(rows).count() == 0


def test_an_empty_archive_and_upload(spark, store):
    winners, log, heads, _, _ = store
    keys = archive.Archive.create(spark.createDataFrame([], KEYS), buckets=4)
    incoming, head = upload(spark, unit(10, "F9", "A", 1))
    done = archive.publish(winners, log, heads, incoming.limit(0), head, keys)
    assert ids(done.winners) == [3, 5] and done.counts.count() == 0



def test_digests_follow_changes(spark, store):
    """Fingerprints by deltas equal those by a scan after publication, deletion and reclassification."""
    winners, log, heads, keys, groups = store
    incoming, head = upload(spark, unit(12, "F9", "C", 1), unit(13, "F9", "E", 1, date="2026-10-28"), unit(14, "F9", None, 1))

    def scan(rows):
        return sorted(map(tuple, facts.day_digests(rows).collect()))

    stored = facts.day_digests(facts.weighted(winners))
    done = archive.publish(winners, log, heads, incoming, head, keys, groups)
    published = done.digests(stored)
    assert sorted(map(tuple, published.collect())) == scan(facts.weighted(done.winners)) != scan(facts.weighted(winners))
    back = archive.delete_file(done.winners, log.unionByName(incoming), done.heads, "DAF", "F9", keys)
    assert sorted(map(tuple, back.digests(published).collect())) == scan(facts.weighted(winners))
    moves = groups.where("model_name = 'M'").withColumn("to_machine", F.lit("2號機"))
    moved = retention.reclassify(groups, moves)
    by_delta = facts.change_digests(facts.day_digests(groups), moves.withColumn("machine", F.col("to_machine")), moves)
    assert sorted(map(tuple, by_delta.collect())) == scan(moved) != scan(groups)
    assert facts.change_digests(stored, None, facts.weighted(winners)).count() == 0
    doubled = facts.change_digests(stored, facts.weighted(winners))
    assert sorted(map(tuple, doubled.collect())) == scan(facts.weighted(winners).unionByName(facts.weighted(winners)))


def test_rules_by_index(spark):
    """Rules shorter than a run of the index, of its length, and longer; repeated rules; no nested loop."""
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "ab", "abc", "xabcx", "zzabczz", "", None, "ABC-123 rev", "日本", "b"])], "id int, product_text string")
    rules = [("contains", "a", "M1"), ("contains", "bc", "M1"), ("contains", "abc", "M1"), ("contains", "abc-123", "M2"), ("contains", "本", "M3"), ("exact", "b", "M4"), ("exact", "B", "M4"), ("contains", "zzabczz", "M5"), ("contains", "nowhere", "M6")]
    table = spark.createDataFrame([(f"r{k}", *r) for k, r in enumerate(rules)], "id string, match_type string, match_text string, model string")
    out = facts.match_rules(texts, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    got = {r.id: (r.model, r.conflict) for r in out.collect()}
    for r in texts.collect():
        value = (r.product_text or "").upper()
        models = {m for kind, t, m in rules if value and (value == t.upper() if kind == "exact" else t.upper() in value)}
        assert got[r.id] == (next(iter(models)) if len(models) == 1 else None, len(models) > 1)


def test_a_lossy_compaction_is_stopped(spark, store):
    """An injected loss fails the run before any key is archived; a clean run archives them."""
    log, keys = store[1], store[3]
    groups = facts.compact_groups(log.limit(0))

    def lossy(winners, old, cutoff):
        stay, merged, moved = retention.compact(winners, old, cutoff)
        return stay, merged.where("status <> 'FAIL'"), moved

    rows = log.withColumn("dedup_key", F.concat(F.lit("new"), "id")).unionByName(spark.createDataFrame([unit(99, "F1", "bad", 1, status="FAIL")], UNIT))
    before = keys.rows().count()
    with pytest.raises(Exception, match="would change the content"):
        retention.compact_verified(rows, groups, dt.date(2026, 12, 1), keys, lossy)
    assert keys.rows().count() == before
    stay, merged = retention.compact_verified(rows, groups, dt.date(2026, 12, 1), keys)
    assert stay.count() == 0 and merged.agg(F.sum("quantity")).first()[0] == 6 and keys.rows().count() == before + 6


def test_stored_state_is_worked_out_once(spark):
    from yieldloom.plans import stores

    # candidates, winners and heads stand written: nothing that is published over them parses the log or ranks it again
    for table in stores._compacted(spark, "/root/testdata/sf0.001")[:4]:
        assert table.inputFiles() and not any("events.parquet" in f for f in table.inputFiles())
