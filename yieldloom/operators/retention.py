"""How long unit rows are kept: the cutoff date, compaction into weighted groups, pruning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions import dates, records
from yieldloom.functions.text import LINES
from yieldloom.operators import election, facts
from yieldloom.sources.sinks import staged


def latest_days(days: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest of each line's distinct days (line, report_day), with day_rank."""
    window = Window.partitionBy("line").orderBy(F.desc("report_day"))
    return days.distinct().withColumn("day_rank", F.row_number().over(window)).where(F.col("day_rank") <= n)


def production_day_cutoff(days: DataFrame, n: int = 7, lines: tuple[str, ...] = LINES, today: dt.date | None = None) -> DataFrame:
    """cutoff: the oldest of the lines' ``n``-th newest producing days, null unless every line has one.
    Days after ``today`` don't count."""
    if today is not None:
        days = days.where(F.col("report_day") <= F.lit(today))
    ranked = latest_days(days.where(F.col("line").isin(*lines)), n)
    per_line = ranked.groupBy("line").agg(F.max(F.when(F.col("day_rank") == n, F.col("report_day"))).alias("day"))
    whole = F.count("day") == len(lines)
    return per_line.agg(F.when(whole, F.min("day")).alias("cutoff"))


def advance_watermark(stored: dt.date | None, days: DataFrame, n: int = 7, today: dt.date | None = None) -> dt.date | None:
    """The later of a stored cutoff and the present one: it never goes back."""
    now = production_day_cutoff(days, n, today=today).first()["cutoff"]
    return max((d for d in (stored, now) if d is not None), default=None)


def advanced(stored: DataFrame, days: DataFrame, n: int = 7, today: dt.date | None = None) -> DataFrame:
    """``stored`` with its ``cutoff`` moved on to the present one, where that is later."""
    now = production_day_cutoff(days, n, today=today).withColumnRenamed("cutoff", "_now")
    return records.with_bounds(stored, now).withColumn("cutoff", F.greatest("cutoff", "_now")).drop("_now")


def dated_before(cutoff: dt.date) -> Column:
    """Whether a row has a valid date before the cutoff."""
    return dates.is_valid_iso_date(F.col("report_date")) & (F.col("report_date") < F.lit(str(cutoff)))


def compact(winners: DataFrame, groups: DataFrame, cutoff: dt.date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unit rows dated before the cutoff move into weighted groups. Returns the unit rows that stay, the
    new groups, and the archived keys (line, dedup_key, dedup_time, file_name). Rows with an invalid date
    stay. Inputs are unchanged; the caller compares :func:`verify_compaction` before writing."""
    old = dated_before(cutoff)
    moved = winners.where(old)
    keys = moved.where(~election.blank()).select("line", "dedup_key", "dedup_time", "file_name")
    return winners.where(~old), facts.compact_groups(moved, groups), keys


def verify_compaction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Weighted content that differs between two fact views; empty if compaction changed nothing."""
    keys = facts.DIMENSIONS
    a, b = (f.groupBy(*keys).agg(F.sum("quantity").alias("quantity")) for f in (before, after))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def compact_verified(winners: DataFrame, groups: DataFrame, cutoff: dt.date, archive=None, compacted=compact) -> tuple[DataFrame, DataFrame]:
    """Unit rows that stay and new groups of a compaction that is proven to change nothing: the groups are written down, the weighted
    content of both states is compared null-safely both ways, and reading the groups fails if any content differs. Only
    then are the keys added to the ``archive``."""
    stay, merged, keys = compacted(winners, groups, cutoff)
    merged = staged(merged)
    lost = verify_compaction(facts.fact_view(winners, None, groups), facts.fact_view(stay, None, merged))
    audited = records.with_bounds(merged, lost.agg(F.count(F.lit(1)).alias("_lost")))
    audited = staged(audited.where(records.require(F.col("_lost") == 0, F.lit("compaction would change the content"))).drop("_lost"))
    if archive is not None:
        archive.append(keys)
    return stay, audited


def migrate_facts(archived: DataFrame, groups: DataFrame) -> DataFrame:
    """Archived unit rows added to weighted groups."""
    return facts.compact_groups(archived, groups)


def prune_superseded(candidates: DataFrame, winners: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates without those that neither win nor belong to a head."""
    return candidates.join(election.superseded(candidates, winners, heads).select("id"), "id", "left_anti")


def prune_ledger(ledger: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """Upload jobs without superseded and failed ones whose last change is older than ``days``."""
    old = F.col("updated_at") < F.lit(now - dt.timedelta(days=days))
    return ledger.where(~(F.col("state").isin("superseded", "failed") & old))


def expire_uploads(ledger: DataFrame, now: dt.datetime, hours: int = 24, recent_minutes: int = 15) -> DataFrame:
    """Incomplete uploads as 'expired' (idle for ``hours``), 'recent' or 'idle': job_id, activity."""
    open_ = ledger.where(~F.col("state").isin("published", "superseded", "failed"))
    idle = F.when(F.col("updated_at") < F.lit(now - dt.timedelta(hours=hours)), "expired").when(F.col("updated_at") >= F.lit(now - dt.timedelta(minutes=recent_minutes)), "recent")
    return open_.select("job_id", idle.otherwise("idle").alias("activity"))


def strip_raw(candidates: DataFrame, keep_from: str, archived_before: str | None, rebuildable: tuple[str, ...] = ("report_date", "status")) -> DataFrame:
    """Raw payloads set to null for rows dated before ``keep_from`` and not archived, where the columns
    ``rebuildable`` are there to rebuild them from."""
    day = F.col("report_date")
    due = dates.is_valid_iso_date(day) & (day < keep_from)
    if archived_before is not None:
        due = due & (day >= archived_before)
    for c in rebuildable:
        due = due & F.col(c).isNotNull()
    return candidates.withColumn("raw", F.when(~due, F.col("raw")))


def preview_strip(candidates: DataFrame, stripped: DataFrame) -> DataFrame:
    """rows, with_raw, to_strip."""
    a = candidates.agg(F.count(F.lit(1)).alias("rows"), F.count("raw").alias("with_raw"))
    b = stripped.agg(F.count("raw").alias("left"))
    return a.crossJoin(b).select("rows", "with_raw", (F.col("with_raw") - F.col("left")).alias("to_strip"))


def reclassify(groups: DataFrame, moves: DataFrame) -> DataFrame:
    """Weighted groups after ``moves`` (the dimensions, to_machine, quantity): quantity goes to the group
    of the new machine; emptied groups drop out."""
    dims = facts.DIMENSIONS
    out = moves.select(*dims, (-F.col("quantity")).alias("quantity"))
    into = moves.select(*[F.col("to_machine").alias("machine") if c == "machine" else F.col(c) for c in dims], "quantity")
    every = groups.select(*dims, "quantity").unionByName(out).unionByName(into)
    return every.groupBy(*dims).agg(F.sum("quantity").alias("quantity")).where("quantity > 0")


def repoint_keys(keys: DataFrame, references: DataFrame) -> DataFrame:
    """Archived keys (…, machine) with the machine of their reference, and whether it changed."""
    ref = references.select("dedup_key", F.col("machine").alias("to_machine"))
    joined = keys.join(ref, "dedup_key", "left")
    return joined.withColumns({"changed": F.col("to_machine").isNotNull() & ~F.col("machine").eqNullSafe(F.col("to_machine")), "machine": F.coalesce("to_machine", "machine")}).drop("to_machine")


def preview_compaction(candidates: DataFrame, winners: DataFrame, heads: DataFrame, groups: DataFrame, cutoff: str) -> DataFrame:
    """line, candidates, winners, losers, invalid_dates, open_jobs, compacted: what compaction would find."""
    old = dates.is_valid_iso_date(F.col("report_date")) & (F.col("report_date") < cutoff)
    win = winners.select(F.col("id").alias("_win"))
    rows = candidates.join(win, F.col("id") == F.col("_win"), "left")
    counts = rows.groupBy("line").agg(
        F.count_if(old).alias("candidates"),
        F.count_if(old & F.col("_win").isNotNull()).alias("winners"),
        F.count_if(old & F.col("_win").isNull()).alias("losers"),
        F.count_if(~dates.is_valid_iso_date(F.col("report_date"))).alias("invalid_dates"),
    )
    jobs = heads.groupBy("line").agg(F.count(F.lit(1)).alias("jobs"))
    done = groups.groupBy("line").agg(F.sum("quantity").alias("compacted"))
    out = counts.join(jobs, "line", "full").join(done, "line", "full")
    zero = dict.fromkeys(("candidates", "winners", "losers", "invalid_dates", "jobs", "compacted"), 0)
    return facts.per_line(candidates.sparkSession, out, zero)


def run_maintenance(winners: DataFrame, candidates: DataFrame, heads: DataFrame, groups: DataFrame, stored_cutoff: dt.date | None, today: dt.date, archive=None) -> dict[str, object]:
    """One maintenance run as new tables: cutoff, winners, groups, keys, candidates. Nothing moves before there is a
    cutoff. What moves is verified (:func:`compact_verified`); ``keys`` are all that the ``archive`` holds then, or
    without one those of this run."""
    cutoff = advance_watermark(stored_cutoff, facts.producing_dates(winners, groups), today=today)
    pruned = prune_superseded(candidates, winners, heads)
    if cutoff is None:
        return {"cutoff": None, "winners": winners, "groups": groups, "keys": None if archive is None else archive.rows(), "candidates": pruned}
    keys = compact(winners, groups, cutoff)[2]
    stay, merged = compact_verified(winners, groups, cutoff, archive)
    return {"cutoff": cutoff, "winners": stay, "groups": merged, "keys": keys if archive is None else archive.rows(), "candidates": strip_raw(pruned, str(today - dt.timedelta(days=30)), str(cutoff)) if "raw" in pruned.columns else pruned}
